"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are the word itself (lexicon), its prefixes and suffixes of one to three letters (affixes) and its letter
pairs and triples with word bounds (n-grams), hashed into one weight table; label-to-label transitions are learned with them.
Training sequences are the whole texts of labelled documents, cut into stretches, and code-switched joins of stretches in two languages, so the
transitions learn how seldom the language changes.  Prediction runs forward-backward over every word of the whole text: the
marginals label each word, their mean over the text labels the document, and that mean is its score.

Fitting takes a bounded sample to the driver: of the ``LANGS`` most frequent languages the first ``DOCS_PER_LANG`` documents by a hash of the id, and of
their stretches, whatever the length of a document, those that come first by a hash of their own, ``WORDS_PER_LANG`` words of a language at
most.  Words are found on the executors.  Predicting is one pass in
place without a shuffle; texts of an Arrow batch become words one by one, ``SLICE`` words at a time, which are cut into groups of like length
of at most ``CELLS`` words, so neither large batches nor long documents take memory.

Cases: a null text, or one without a letter, is ``und`` with score 0; letters are those of any script (Unicode's categories L), composed where they can
be; marks belong to the word that they stand in, all else, numbers of any kind too, parts words; rows with a null lang or text don't train; with one language learned every other text is in it, with score 1, with none
every text is ``und``; repeated rows are predicted each; ties go to the language first in order; an empty table gives no
rows; the columns of the input are kept, but for those named like a result.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Collection, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.common import dealt_out, materialize

#: Bounds of the sample that a model is fitted on.
DOCS_PER_LANG, WORDS_PER_LANG, LANGS = 250, 25_000, 64
#: Words of a training stretch.
STRETCH = 48
ROUNDS, RATE, SHRINK = 40, 0.3, 1e-4
SLOTS = 1 << 17
#: Words of a group of texts of like length, and of the texts among which groups are formed.
CELLS, SLICE = 1 << 17, 1 << 20
CACHED_WORDS = 200_000
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def tokens(text: str | None) -> list[str]:
    """Runs of letters with their marks, composed and in lower case."""
    return _WORD.findall(unicodedata.normalize("NFC", text).lower()) if text else []


def word_features(word: str) -> list[int]:
    """Slots of the lexicon, affix and n-gram features of a word."""
    names = ["=" + word]
    for k in (1, 2, 3):
        names += ["<" + word[:k], ">" + word[-k:]]
    bound = f"^{word}$"
    names += [bound[i : i + 2] for i in range(len(bound) - 1)] + [bound[i : i + 3] for i in range(len(bound) - 2)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % SLOTS for n in names]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (time, text, label) and the expected label pairs, for texts in falling order of length.

    scores: (time, text, label) emission scores; moves: (label, label) transition scores.  Each step is rescaled.
    """
    t_max, _, n = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max())
    alive = np.searchsorted(-lengths, -np.arange(t_max), side="left")  # texts that have a word at each time
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    alpha[0, : alive[0]] = e[0, : alive[0]]
    alpha[0, : alive[0]] /= alpha[0, : alive[0]].sum(axis=1, keepdims=True)
    for t in range(1, t_max):
        k = alive[t]
        x = (alpha[t - 1, :k] @ a) * e[t, :k]
        alpha[t, :k] = x / x.sum(axis=1, keepdims=True)
    pairs = np.zeros((n, n))
    for t in range(t_max - 2, -1, -1):
        k = alive[t + 1]
        after = e[t + 1, :k] * beta[t + 1, :k]
        x = after @ a.T
        beta[t, :k] = x / x.sum(axis=1, keepdims=True)
        z = np.einsum("bi,bi->b", alpha[t, :k], x)
        pairs += (alpha[t, :k] / z[:, None]).T @ after
    m = alpha * beta
    m /= np.maximum(m.sum(axis=2, keepdims=True), 1e-30)
    return m, pairs * a


class Crf:
    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray):
        self.langs, self.weights, self.moves = langs, weights, moves
        self._index: dict[str, int] = {}
        self._table = np.zeros((1024, len(langs)), np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights, "moves": self.moves}

    def __setstate__(self, state):
        self.__init__(**state)

    def ids(self, words: list[str]) -> list[int]:
        """Places of the words in the table of emission scores, which is filled as words come."""
        index = self._index
        got = [index.get(w, -1) for w in words]
        if -1 in got:
            for i, w in enumerate(words):
                if got[i] < 0:
                    k = index.get(w)
                    if k is None:
                        k = index[w] = len(index)
                        if k == len(self._table):
                            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
                        self._table[k] = self.weights[word_features(w)].sum(axis=0)
                    got[i] = k
        return got

    def marginals(self, texts: Iterable[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, (word, label) marginals) for each text with words.  Texts are taken until they have ``SLICE`` words, and their words become numbers text by
        text, so neither a batch's words nor their numbers are held."""
        first, words, places = 0, 0, []
        for text in texts:
            places.append(np.array(self.ids(text), np.int32))
            words += len(places[-1])
            if words >= SLICE:
                yield from self._marginals(places, first)
                first, words, places = first + len(places), 0, []
        yield from self._marginals(places, first)

    def _marginals(self, places: list[np.ndarray], first: int) -> Iterator[tuple[int, np.ndarray]]:
        """The marginals of texts given by their words' places; ``first`` is the first text's number."""
        order = sorted((i for i in range(len(places)) if len(places[i])), key=lambda i: -len(places[i]))
        at = 0
        while at < len(order):
            longest = len(places[order[at]])
            group = order[at : at + max(1, CELLS // longest)]
            at += len(group)
            lengths = np.array([len(places[i]) for i in group])
            scores = np.zeros((longest, len(group), len(self.langs)), np.float32)
            for j, i in enumerate(group):
                scores[: lengths[j], j] = self._table[places[i]]
            m, _ = forward_backward(scores, lengths, self.moves.astype(np.float32))
            for j, i in enumerate(group):
                yield first + i, m[: lengths[j], j]
        if len(self._index) > CACHED_WORDS:  # the words that came first are the more frequent ones
            self._index = dict(islice(self._index.items(), CACHED_WORDS // 2))

    def predict(self, texts: Collection[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Of each text its language, the score of that, and how many of its words are labelled with another; texts are iterated over once."""
        langs, scores, others = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
        if self.langs:
            for i, m in self.marginals(map(tokens, texts)):
                mean = m.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                langs[i], scores[i], others[i] = self.langs[best], float(min(1.0, mean[best])), int((m.argmax(axis=1) != best).sum())
        return langs, scores, others

    def word_labels(self, text: str) -> list[tuple[str, str]]:
        """(word, language) for each word of a code-switched text."""
        words = tokens(text)
        return [(w, self.langs[k]) for _, m in self.marginals([words]) for w, k in zip(words, m.argmax(axis=1), strict=True)] if self.langs else []


def _stretches(words: list[str]) -> list[list[str]]:
    return [words[i : i + STRETCH] for i in range(0, len(words), STRETCH)]


def train(rows: list[tuple[list[str], str]], seed: int = 7) -> Crf:
    """A model of (words, lang) rows."""
    langs = sorted({lang for _, lang in rows})
    if len(langs) < 2:
        return Crf(langs, np.zeros((SLOTS, len(langs)), np.float32), np.zeros((len(langs), len(langs))))
    code = {lang: i for i, lang in enumerate(langs)}
    plain = [(s, [code[lang]] * len(s)) for words, lang in rows for s in _stretches(words)]
    rng = np.random.default_rng(seed)
    mixed = []
    for i, j in zip(rng.permutation(len(plain)), rng.permutation(len(plain)), strict=True):
        (a, la), (b, lb) = plain[i], plain[j]
        cut = int(rng.integers(STRETCH // 4, STRETCH))
        mixed.append((a[:cut] + b[:cut], la[:cut] + lb[:cut]))
    data = sorted(plain + mixed[: len(plain) // 2], key=lambda x: -len(x[0]))

    vocabulary: dict[str, int] = {}
    ids = [[vocabulary.setdefault(w, len(vocabulary)) for w in words] for words, _ in data]
    features = [word_features(w) for w in vocabulary]
    sizes = np.array([len(f) for f in features])
    flat, cuts = np.concatenate([np.array(f) for f in features]), np.r_[0, np.cumsum(sizes)[:-1]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    lengths = np.array([len(x) for x in ids])
    n, t_max, b = len(langs), int(lengths[0]), len(ids)
    place, truth, there = np.zeros((t_max, b), np.int64), np.zeros((t_max, b), np.int64), np.zeros((t_max, b), bool)
    for j, (x, (_, y)) in enumerate(zip(ids, data, strict=True)):
        place[: len(x), j], truth[: len(x), j], there[: len(x), j] = x, y, True
    gold_pairs = np.zeros((n, n))
    np.add.at(gold_pairs, (truth[:-1][there[1:]], truth[1:][there[1:]]), 1)
    gold = np.eye(n)[truth[there]]

    weights, moves = np.zeros((SLOTS, n)), np.zeros((n, n))
    seen_w, seen_m = np.full((SLOTS, n), 1e-8), np.full((n, n), 1e-8)
    total = there.sum()
    for _ in range(ROUNDS):  # full-batch gradient steps, scaled by Adagrad
        table = np.add.reduceat(weights[flat], cuts, axis=0)
        m, pairs = forward_backward(table[place], lengths, moves)
        off = gold - m[there]
        by_word = np.stack([np.bincount(place[there], off[:, k], len(sizes)) for k in range(n)], axis=1)
        g = np.stack([np.bincount(flat, by_word[owner, k], SLOTS) for k in range(n)], axis=1) / total - SHRINK * weights
        gm = (gold_pairs - pairs) / total - SHRINK * moves
        seen_w += g * g
        seen_m += gm * gm
        weights += RATE * g / np.sqrt(seen_w)
        moves += RATE * gm / np.sqrt(seen_m)
    return Crf(langs, weights.astype(np.float32), moves)


def sample(docs: DataFrame, per_lang: int = DOCS_PER_LANG, words_per_lang: int = WORDS_PER_LANG) -> DataFrame:
    """(words, lang): stretches of the first ``per_lang`` documents of each language by a hash of the id, in an order of their own until they have
    ``words_per_lang`` words."""
    rows = docs.where("text is not null and lang is not null")
    # broadcast, so that rows are thinned out where they are read and only the sample is shuffled
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGS), "languages")
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("crf")), F.lit(1 << 40))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("_n"))
    some = rows.select("doc_id", "text", "lang").join(F.broadcast(counts), "lang").withColumn("_o", order).where(F.col("_o") < share * (1 << 40))
    # only texts of a language's first ``per_lang`` documents become words
    nth = Window.partitionBy("lang").orderBy("_o", "doc_id", "text")
    first = some.withColumn("_k", F.row_number().over(nth)).where(F.col("_k") <= per_lang)
    # no filter on what the function returns: it would run twice, in two Python workers a task, and idle workers keep their memory
    split = F.pandas_udf(lambda texts: pd.Series([_stretches(tokens(t)) for t in texts]), "array<array<string>>")
    each = first.select("_k", "lang", F.posexplode(split(F.col("text"))).alias("_i", "words"))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("_k", "_i"), "_k", "_i")
    return each.withColumn("_w", F.sum(F.size("words")).over(by)).where(F.col("_w") <= words_per_lang).select("words", "lang")


def fit(docs: DataFrame, per_lang: int = DOCS_PER_LANG, words_per_lang: int = WORDS_PER_LANG) -> Crf:
    """A model of labelled ``docs`` (doc_id, text, lang)."""
    return train(sorted((r["words"], r["lang"]) for r in sample(docs, per_lang, words_per_lang).collect()))


class _Texts(Collection):
    """The texts of an Arrow array, of which one at a time becomes a string."""

    def __init__(self, texts: pa.Array):
        self._texts = texts

    def __len__(self) -> int:
        return len(self._texts)

    def __iter__(self) -> Iterator[str | None]:
        return (text.as_py() for text in self._texts)

    def __contains__(self, text: object) -> bool:
        return any(text == t for t in self)


def predict(docs: DataFrame, model: Crf, text: str = "text", lang: str = "lang_pred", score: str = "score", others: str = "n_other") -> DataFrame:
    """``docs`` with the predicted language, its score and the number of words in other languages in columns of those names."""

    def guess(texts: pa.Array) -> pa.Array:
        langs, scores, others = model.predict(_Texts(texts))
        pa.default_memory_pool().release_unused()  # of earlier batches, which an idle worker would hold
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(others, pa.int32())], ["lang", "score", "others"])

    got = F.arrow_udf(guess, "lang string, score double, others int")(F.col("_text"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {lang.lower(), score.lower(), others.lower()}]
    done = dealt_out(docs).select(F.struct(*kept).alias("_kept"), F.col(text).alias("_text")).select("_kept", got.alias("_crf"))
    return done.select("_kept.*", F.col("_crf.lang").alias(lang), F.col("_crf.score").alias(score), F.col("_crf.others").alias(others))
