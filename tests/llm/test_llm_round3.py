"""Fill-in-the-middle, source divergence and the n-gram join: exact round trips, SQL, brute force, odd rows."""

import hashlib
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxloom.llm import fill_in_middle, ngram_jaccard, source_divergence
from taxloom.llm import queries as q
from taxloom.llm.common import Work

DOCS = "doc_id long, text string, lang string, source string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def clash(df, *names):
    return df.select("*", *[F.lit(7).alias(n) for n in names])


# --- fill in the middle


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\tabé中\U0001f600 <PSM>"), max_size=300), st.integers(0, 400), st.sampled_from([1, 2, 7, 64]))
def test_cuts_equal_a_list_of_units(text, unit, every):
    units, raw = UNIT.findall(text), text.encode()
    known = fill_in_middle.counted(raw, every)
    assert known.n == len(units) and all(b - a == every for a, b in zip(known.units, known.units[1:], strict=False))
    unit = min(unit, known.n)
    head = "".join(units[:unit])
    assert fill_in_middle.cut(raw, known, unit) == (len(head.encode()), len(head))


def test_fill_in_middle_cases(spark):
    long = "wörd  \n" * 50_000
    rows = [(i, f"one two {i} three\n four ", "en", "s") for i in range(60)] + [(1, "one two 1 three\n four ", "en", "s"), (100, None, None, None), (101, "", "", ""), (102, "a <S> b", "en", "s"), (103, " \n ", "en", "s"), (None, "no id", "en", "s"), (104, long, "en", "s")]
    docs = clash(spark.createDataFrame(rows, DOCS), "N", "form", "_kept", "_fim", "other")
    done = fill_in_middle.fill_in_middle(docs)
    assert {"lang", "source", "other", "_kept", "_fim", "n", "form", "output"} < set(done.columns) and "text" not in done.columns and "N" not in done.columns
    got = done.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, t or "") for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.back) for r in got) == want and all(r.other == 7 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0] == by[1][1] and {r.form for r in got} == {"plain", "psm", "spm"}
    assert by[100][0].n == by[101][0].n == 0 and by[100][0].form == by[102][0].form == "plain" and by[103][0].n == 1 and by[104][0].n == 50_001
    for r in got:
        if r.form != "plain":
            assert r.output != r.back and r.prefix_chars + r.middle_chars <= len(r.back)
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_draws_follow_the_contract():
    h = hashlib.sha256(b"42:17").hexdigest()
    assert fill_in_middle.draws(17) == [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


# --- source divergence


def divergence(rows, least=3, top=200):
    """The definition over plain dictionaries."""
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for _, text, lang, source in rows]
    out = {}
    for lang in {x[0] for x in docs}:
        seen = Counter(t for x in docs if x[0] == lang for t in x[2])
        kept = sorted(t for t, n in seen.items() if n >= least)
        count = defaultdict(Counter)
        for la, source, words in docs:
            if la == lang:
                count[source].update({t: n for t, n in words.items() if t in set(kept)})
        count = {s: count[s] for s in {x[1] for x in docs if x[0] == lang}}
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in count.items():
            pairs = {o: sum(f(p(c, t), p(d, t)) for t in kept) for o, d in count.items() if o != s}
            terms = {t: f(p(c, t), p(whole, t)) for t in kept if c[t] and p(c, t) > p(whole, t)}
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item] = (value, rank)
    return out


def odd_docs():
    rng = np.random.default_rng(7)
    words = ["Alpha", "beta", "GAMMA", "été", "ß", "Ä", "中文", "delta2x", "e-f"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 7], 1 + i % 13)), ["en", "de", None][i % 3], ["a", "b", "c", None, "Z", "é"][i % 6 if i % 3 else i % 2]) for i in range(90)]
    return [*rows, (200, None, "en", "silent"), (201, "", "xx", "only"), (202, "one two", "xx", "more"), (203, "12 34", None, None), (5, rows[5][1], *rows[5][2:]), (None, "Alpha alpha", "en", "a"), (204, "w " * 40_000, "en", "b")]


@pytest.mark.parametrize("top,group_rows", [(200, 20_000), (2, 3)])
def test_divergence_equals_the_definition(spark, top, group_rows):
    rows = odd_docs()
    docs = clash(spark.createDataFrame(rows, DOCS), "term", "n", "p", "item", "value")
    got = source_divergence.source_divergence(docs, top=top, group_rows=group_rows).collect()
    assert {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in got} == divergence(rows, top=top) and len(got) == len(divergence(rows, top=top))
    assert source_divergence.source_divergence(docs.limit(0)).count() == 0


def test_divergence_flushes_and_slices(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 64)
    monkeypatch.setattr(source_divergence, "HELD_ROWS", 5)
    rows = [(t or "", la or "", s or "") for _, t, la, s in odd_docs()]
    batch = pa.RecordBatch.from_pylist([{"text": t, "lang": la, "source": s} for t, la, s in rows])
    total = Counter()
    for out in source_divergence._count(iter([batch, batch.slice(0, 0), batch.slice(7)])):
        for r in out.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter()
    for t, la, s in rows + rows[7:]:
        want.update((la, s, w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    assert total == want


# --- n-gram join


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def plain_components(docs):
    sets = {i: plain_set(t) for i, t in docs.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for a, s in sets.items():
        for b in {b for x in s for b in where[x] if b < a}:
            if 100 * len(s & sets[b]) >= 85 * len(s | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_join_query_equals_brute_force(spark, duck, data):
    docs = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = q.op13_ngram_jaccard(spark, data).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(docs) and len(got) == len(docs)


def test_join_of_chains_passages_and_borders(spark):
    """Near copies in chains (ends don't link), a passage in many texts, pairs just at and just below the limit, sizes on both sides of a band."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    texts = []
    for _ in range(6):
        t = [word() for _ in range(150)]
        for _ in range(25):
            t = list(t)
            t[rng.integers(0, len(t))] = word()
            if rng.random() < 0.3:
                t = t[rng.integers(0, 3) :] + [word()]
            texts.append(" ".join(t))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(rng.integers(0, 9))]) for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(k)]) for k in range(30)]
    base = [word() for _ in range(103)]  # 100 runs
    texts += [" ".join(base[:k]) for k in range(70, 104)] + [" ".join(base).upper(), " ".join(base[50:] + base[:50])]
    texts += ["a b c", "A  b\tc", "a b", "", " \n", None, "x " * 5_000, "x x x x"]
    docs = dict(enumerate(texts, 1000))
    frame = clash(spark.createDataFrame([(i, t, "en", "s") for i, t in docs.items()], DOCS), "n", "keys", "k", "band", "t", "rep")
    got = ngram_jaccard.jaccard_components(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(docs)
    twice = frame.union(frame.where("doc_id % 3 = 0")).union(frame.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(twice).collect()} == plain_components(docs)
    assert ngram_jaccard.jaccard_components(frame.limit(0)).count() == 0


def test_join_takes_one_text_of_an_id(spark):
    rows = [(1, "a b c d e", "en", "s"), (1, "v w x y z", "en", "s"), (2, "a b c d e", "en", "s"), (3, "v w x y z", "en", "s")]
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == 1 and sorted([got[2], got[3]])[0] == 1 and len(set(got.values())) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB \n\t\x1f é\U0001f600"), max_size=40), max_size=8))
def test_sets_of_bytes_equal_sets_of_words(texts):
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]).astype(np.int64)
    keys = [set(k.tolist()) for k in ngram_jaccard.sets_of(data, ends)]
    plain = [plain_set(t) for t in texts]
    assert [len(k) for k in keys] == [len(p) for p in plain]
    for a, p in zip(keys, plain, strict=True):
        for b, o in zip(keys, plain, strict=True):
            assert len(a & b) == len(p & o)


def test_bitmaps_bound_the_intersection():
    rng = np.random.default_rng(5)
    for n in (1, 40, 3_000):
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        for share in (0.0, 0.5, 0.9, 1.0):
            b = np.unique(np.r_[a[: int(share * len(a))], rng.integers(0, 2**63, n // 3 + 1, np.uint64)])
            apart = int(np.bitwise_count(ngram_jaccard.bits(a).view(np.uint64) ^ ngram_jaccard.bits(b).view(np.uint64)).sum())
            assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - apart) // 2


def test_join_holds_less_on_disk_than_its_texts(spark, monkeypatch):
    """Long near copies: the tables that the join holds after each write are less than 0.6 of the texts, and what was shuffled to count keys is gone when the sets are written."""
    rng = np.random.default_rng(8)
    docs = {}
    for i in range(40):
        t = [f"w{x}" for x in rng.integers(0, 5_000, 2_000)]
        for j in range(5):
            docs[5 * i + j] = " ".join([*t[: 300 * j], "odd", *t[300 * j :]])
    size = sum(map(len, docs.values()))
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {p: p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*") if p.exists()}
    earlier, held, left = set(shuffled()), {}, []
    write = Work.write

    def watched(work, df, label):
        out = write(work, df, label)
        held[len(held), label] = sum(p.stat().st_size for p in Path(work.path.removeprefix("file:")).rglob("*.parquet"))
        if label == "sets":
            for _ in range(25):  # files go a moment after the query
                left[:] = [n for p, n in shuffled().items() if p not in earlier]
                if sum(left) < size / 100:
                    break
                time.sleep(0.2)
        return out

    monkeypatch.setattr(Work, "write", watched)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame([(i, t, "en", "s") for i, t in docs.items()], DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 5 for i in docs}
    assert sum(left) < size / 100, (left, size)
    assert max(held.values()) < 0.6 * size, (held, size)


def test_intersections_of_zipped_texts(spark):
    texts = ["a b c d e f", "A b c d e g", "a b", "a\tB", "", None, "x " * 5_000, "é ü a b c d e f"]
    rows = [(i, j, x, y) for i, x in enumerate(texts) for j, y in enumerate(texts)]
    zips = spark.createDataFrame(rows, "i int, j int, x string, y string").select("i", "j", *[ngram_jaccard.zipped(F.col(c).cast("binary")).alias(c) for c in "xy"])
    for r in zips.select("i", "j", ngram_jaccard.shared(4)("x", "y").alias("n")).collect():
        assert r.n == len(plain_set(texts[r.i]) & plain_set(texts[r.j])), r
