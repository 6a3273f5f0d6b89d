"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxloom.llm import chat_schema, crf_langid, decontaminate, line_dedup, order_minhash, packing, token_ledger, topk_postings, toxicity, url_reputation

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
EN, DE = "the of and with that this from only", "der die das und nicht mit eine auch"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts, languages and sources, empty, blank and very long texts, repeated rows."""
    rows = [
        (1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (2, None, "en", "s", None), (3, "", None, None, 0), (4, "  \n\t ", "de", "s", 5), (5, LONG, "en", None, len(LONG)),
        (6, "A  b c d e f g H", "en", "t", 16), (None, "null id text here now", "en", "s", 21), (7, "12 34 !!", "fr", "s", 8), (8, LONG + " tail", "en", "s", 1), (9, EN + "\n" + EN, "en", "s", 1), (10, DE, "de", "s", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def clash(df, *names):
    return df.select("*", *[F.lit(7).alias(n) for n in names])


def test_line_dedup(spark, odd):
    pages = spark.createDataFrame([(i, "h", f"own line {i}\nMENU") for i in range(40)] + [(99, "h", "MENU"), (98, "h", None), (97, None, "MENU\n\nx")], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(clash(pages, "n_lines", "host", "lines", "_extra")).collect()}
    assert got[3].text == "own line 3" and got[3].n_dropped == 1 and got[99].text == "" and got[99].n_dropped == 1 and got[98].text is None and got[97].text == "MENU\n\nx" and got[3]._extra == 7
    assert {r.doc_id: r for r in line_dedup.drop_boilerplate(pages, keep_whole=True).collect()}[99].text == "MENU"
    assert line_dedup.drop_boilerplate(odd).count() == 12 and line_dedup.drop_boilerplate(odd.limit(0)).count() == 0


def test_token_ledger(spark, odd, tmp_path):
    ledger = token_ledger.TokenLedger(spark, f"file://{tmp_path}/l")
    rows = token_ledger.counted(clash(odd, "op2", "n_tokens"), F.pandas_udf(lambda s: s.fillna("").str.split().str.len(), "long"), "words")
    assert ledger.totals().count() == 0
    ledger.commit("a", rows.withColumn("op", F.lit("insert")))
    first = sorted(map(tuple, ledger.totals().collect()), key=str)
    assert sum(r[3] for r in first) == 10
    assert not ledger.commit("a", rows.withColumn("op", F.lit("insert")).limit(1)) and ledger.commit("b", rows.withColumn("op", F.lit("insert")))
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == first
    ledger.commit("c", rows.where("doc_id in (1, 5)").withColumn("op", F.lit("delete")))
    ledger.commit("d", rows.where("doc_id = 8").withColumn("n_tokens", F.lit(5).cast("long")).withColumn("op", F.lit("revise")))
    assert sum(r.n_docs for r in ledger.totals().collect()) == 8 and ledger.contributions().where("doc_id = 8").first().n_tokens == 5
    ledger.commit("e", rows.limit(0).withColumn("op", F.lit("insert")))
    assert ledger.batches() == list("abcde")
    before = sorted(map(tuple, ledger.totals().collect()), key=str)
    ledger.compact()
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == before and ledger.contributions().count() == 8
    # a job that died between a batch's two writes leaves rows that nobody reads, and may be run again
    lost = rows.where("doc_id = 9").withColumn("op", F.lit("delete"))
    ledger.entries().limit(3).write.parquet(f"file://{tmp_path}/l/documents/batch=f")
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == before and ledger.contributions().count() == 8
    assert ledger.commit("f", lost) and ledger.contributions().count() == 7
    # the last change of a document in a batch that numbers them
    both = rows.where("doc_id = 9").withColumn("op", F.lit("insert")).withColumn("seq", F.lit(1)).union(lost.withColumn("seq", F.lit(2)))
    ledger.commit("g", both)
    assert ledger.contributions().where("doc_id = 9").count() == 0
    ledger.commit("h", both.withColumn("seq", -F.col("seq")))
    assert ledger.contributions().where("doc_id = 9").first().n_docs == 1
    with pytest.raises(ValueError):
        ledger.commit("x/y", rows.withColumn("op", F.lit("insert")))


def test_near_duplicates(spark, odd):
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(clash(odd, "rep", "bucket", "k1", "a")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1, 7: 7, 8: 5, 9: 9, 10: 10}
    assert order_minhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicate_groups_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [f"t{x}" for x in rng.integers(0, 500, 120)]
    texts = []
    for i in range(60):
        w = list(base) if i % 3 else [f"t{x}" for x in rng.integers(0, 500, 120)]
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 120))] = f"e{i}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(116)} for t in texts]
    root = list(range(60))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(60):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in range(60)}


def test_near_duplicates_in_hot_buckets(spark):
    """A passage that is 87% of many unlike documents, and pairs of them with a little more in common."""
    passage = [f"p{i}" for i in range(104)]
    texts = []
    for i in range(600):
        same = [f"s{i}x{j}" for j in range(7)] if i < 40 else []
        for half in "ab":
            texts.append(" ".join(passage + [f"o{i}{half}{j}" for j in range(15 - len(same))] + same))
    order = np.random.default_rng(3).permutation(1200)
    sets = [{tuple(t.split()[j : j + 5]) for j in range(115)} for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert [like(2 * i, 2 * i + 1) for i in range(600)] == [i < 40 for i in range(600)] and not any(like(a, b) for a in (0, 999) for b in range(1200) if b // 2 != a // 2)
    got = order_minhash.near_duplicates(spark.createDataFrame([(int(order[i]), t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sum(r.class_id != r.doc_id for r in got.collect()) == 40


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.root for r in order_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_sketch_follows_order():
    with np.errstate(over="ignore"):
        w = np.arange(200)
        a, b = order_minhash.labelled_kmers(w), order_minhash.labelled_kmers(np.r_[w[100:], w[:100]])
        assert order_minhash.aligned(a, a, 0.8) == 1 and order_minhash.aligned(a, b, 0.8) == 0
        twice = order_minhash.labelled_kmers(np.r_[w, w])
        assert len(set(twice.tolist())) == len(twice)
        same = order_minhash.sketches(a, 8)
        assert (same == order_minhash.sketches(a.copy(), 8)).all() and (same != order_minhash.sketches(b, 8)).any()


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.Example.ORG/es/x?q#f"), (4, "http://b.net?x/y"), (4, "http://b.net?x/y"), (None, "http://com/de/"), (5, "x://bad.net/p")], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1)] + [(i, 1) for i in range(100, 160)], "page_id long, bad int")
    more = pages.union(spark.createDataFrame([(i, "http://w.bad.net/") for i in range(100, 160)] + [(i, f"http://ok{i}.org/") for i in range(200, 260)], "page_id long, url string"))
    ok = labels.union(spark.createDataFrame([(i, 0) for i in range(200, 260)], "page_id long, bad int"))
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")]
    got = {r.page_id: r for r in url_reputation.judge_urls(clash(more, "host", "n", "x", "bad"), ok, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None) and (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[4].host, got[4].path) == ("b.net", "") and got[None].verdict == "block" and got[100].verdict == "block" and got[200].verdict == "allow"
    assert url_reputation.judge_urls(pages.limit(0), labels.limit(0), rules).count() == 0
    long = spark.createDataFrame([(1, "http://a.b.org/" + "p/" * 200_000 + "?q"), (2, "x://" + "a." * 50_000 + "org")], "page_id long, url string")
    assert {r.page_id: (len(r.path), r.rule) for r in url_reputation.judge_urls(long, labels, rules).collect()} == {1: (400_001, "org/"), 2: (0, None)}


def test_domains_and_suffixes(spark):
    want = {
        "w.a.co.uk": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.org": ("b.org", "org"), "org": ("org", "org"), "": ("", ""), "me:pw@w.b.org:8080": ("b.org", "org"), "b.org.": ("b.org", "org"),
        "10.0.0.1": ("10.0.0.1", "*"), "10.0.0.1:80": ("10.0.0.1", "*"), "[::1]:80": ("[::1]", "*"), "1.2.3": ("2.3", "3"), "x.y.city.gov.example": ("y.city.gov.example", "city.gov.example"),
    }
    suffixes = (*url_reputation.LONG_SUFFIXES, "city.gov.example", "gov.example")
    name = url_reputation.name_of(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", url_reputation.domain_of(name, suffixes).alias("d"), url_reputation.suffix_of(name, suffixes).alias("s"))
    assert {r.host: (r.d, r.s) for r in rows.collect()} == want


def test_language(spark, odd):
    rows = spark.createDataFrame([(i, EN + f" {i}" if i % 2 else DE, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    # equal evidence for both: ties go to the first language
    even = crf_langid.Crf(["aa", "bb"], np.zeros((crf_langid.SLOTS, 2), np.float32), np.zeros((2, 2)))
    assert even.predict(["one two", None]) == (["aa", "und"], [0.5, 0.0], [0, 0])
    # stretches of the first documents in hash order, within the bounds of rows and words
    assert crf_langid.sample(rows, per_lang=9).count() == 18 and crf_langid.sample(rows, words_per_lang=8 * 20).groupBy("lang").count().where("count <> 20").count() == 0
    # a text of any length may train: of a long one some stretches, and never more words than the bound
    mixed = rows.union(spark.createDataFrame([(1000, LONG.replace("x", "") + " " + " ".join(f"long{chr(97 + i % 26)}" for i in range(20_000)), "en")], rows.schema))
    drawn = crf_langid.sample(mixed, words_per_lang=3_000).where("lang = 'en'").collect()
    assert sum(len(r.words) for r in drawn) <= 3_000 and any(w.startswith("long") for r in drawn for w in r.words) and max(len(r.words) for r in drawn) <= crf_langid.STRETCH
    model = crf_langid.fit(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in crf_langid.predict(clash(odd, "lang_pred", "score"), model).collect()}
    assert got[2] == ("und", 0.0) and got[3] == ("und", 0.0) and got[7] == ("und", 0.0) and got[9][0] == "en" and got[10][0] == "de"
    labels = [x for _, x in model.word_labels(EN + " " + DE)]
    assert labels[0] == "en" and labels[-1] == "de" and len(set(labels)) == 2
    assert crf_langid.predict(odd, crf_langid.fit(rows.limit(0))).where("lang_pred = 'und'").count() == 12
    one = crf_langid.predict(odd, crf_langid.fit(rows.where("lang = 'en'"))).where("doc_id = 10").first()
    assert (one.lang_pred, one.score) == ("en", 1.0) and crf_langid.predict(odd.limit(0), model).count() == 0


def test_words_are_letters_with_their_marks(spark):
    """Numbers of any kind are no letters; marks don't part words; composed and decomposed texts are alike; the caller's columns stay."""
    assert crf_langid.tokens("½ ²³ Ⅷ ① 12 _ - \u0301") == [] and crf_langid.tokens(None) == []
    assert crf_langid.tokens("हिन्दी nai\u0308ve naïve x\u0301y İstanbul A1b") == ["हिन्दी", "naïve", "naïve", "x\u0301y", "i\u0307stanbul", "a", "b"]
    rows = spark.createDataFrame([(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    model = crf_langid.fit(rows)
    odd = spark.createDataFrame([(1, "½ ²³ Ⅷ", 5, 6, 7), (2, EN, 5, 6, 7)], "doc_id long, text string, _crf int, _kept int, _text int")
    got = {r.doc_id: r for r in crf_langid.predict(odd, model).collect()}
    assert (got[1].lang_pred, got[1].score) == ("und", 0.0) and got[2].lang_pred == "en" and (got[2]._crf, got[2]._kept, got[2]._text) == (5, 6, 7)


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    s, moves = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    want, total = np.zeros((4, 3)), 0.0
    for path in product(range(3), repeat=4):
        p = np.exp(sum(s[t, 0, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, k in enumerate(path):
            want[t, k] += p
    m, pairs = crf_langid.forward_backward(s, np.array([4]), moves)
    assert np.allclose(m[:, 0], want / total) and np.isclose(pairs.sum(), 3)


def test_top_k(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, []), (None, [1.0, 1.0]), (7, [-3.0, 0.5]), (0, [9.0, 9.0])], "vec_id long, embedding array<double>")
    v = clash(rows, "rank", "score", "chunk").select("vec_id", topk_postings.quantized(F.col("embedding")).alias("v"))
    got = topk_postings.top_k(v, v.where("vec_id = 0"), k=3, block_bytes=64).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 5 * 1024**2), (2, 2, 5 * 1024**2), (3, 6, 0)]
    assert topk_postings.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_against_brute_force(spark, monkeypatch):
    """Several blocks of queries, small chunks, ties, repeated rows and scores at the ends of 64 bits."""
    monkeypatch.setattr(topk_postings, "CHUNK", 7)
    monkeypatch.setattr(topk_postings, "ROWS", 3)
    rng = np.random.default_rng(6)
    rows = [(i, [int(x) for x in rng.integers(-2, 3, 5)]) for i in range(60)] + [(61, [1, 1, 1, 1, 1])] * 5 + [(62, [2**40] * 5), (63, [-(2**40)] * 5)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk_postings.top_k(v, v.where("vec_id % 5 = 0 or vec_id > 60"), k=4, block_bytes=400).collect()
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = set()
    for q, a in {i: x for i, x in rows if i % 5 == 0 or i > 60}.items():
        scored = sorted((-cut(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in rows if i != q)[:4]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in got} == want and len(got) == 4 * len({r[0] for r in want})


def test_chat(spark):
    said = "</s>[INST] \\ <|end|> ok"
    layouts = {
        1: {"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}], "id": 3},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        3: {"instruction": "i", "input": "", "output": "o", "n": {"a": [1]}}, 4: {"prompt": "p", "completion": None, "system": "s"}, 5: {"turns": []}, 6: {"question": "q", "context": "c", "answer": "a"}, 7: {"foo": 1},
    }
    rows = spark.createDataFrame([(k, json.dumps(x)) for k, x in layouts.items()] + [(8, "{broken"), (9, None)], "conv_id long, record string")
    out = chat_schema.format_turns(chat_schema.canonical_turns(clash(rows, "turns", "layout", "formatted")))
    out = out.select("conv_id", "layout", "turns", "formatted", chat_schema.read_turns(F.col("formatted")).alias("back"), chat_schema.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert all(r.turns == r.back for r in got.values() if r.turns is not None)
    assert got[1].loss == [said] and [tuple(t) for t in got[2].turns] == [("user", "q"), ("assistant", "a")] and [t.text for t in got[3].turns] == ["i", "o"]
    assert [tuple(t) for t in got[4].turns] == [("system", "s"), ("user", "p"), ("assistant", "")] and got[5].formatted == "" and got[6].turns[0].text == "c\n\nq"
    assert got[7].turns is None and got[8].layout is None and got[9].formatted is None
    assert chat_schema.format_turns(chat_schema.canonical_turns(rows.limit(0))).count() == 0
    long = said * 100_000
    more = rows.union(rows).union(spark.createDataFrame([(10, json.dumps({"turns": [{"role": "assistant", "text": long}, {"role": "user", "text": ""}]}))], rows.schema))
    chats = chat_schema.format_turns(chat_schema.canonical_turns(more)).select("conv_id", "formatted", chat_schema.read_turns(F.col("formatted")).alias("back"), chat_schema.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(chats) == 19 and all(r.formatted == got[r.conv_id].formatted for r in chats if r.conv_id < 10)
    (whole,) = [r for r in chats if r.conv_id == 10]
    assert [tuple(t) for t in whole.back] == [("assistant", long), ("user", "")] and whole.loss == [long]


def test_decontamination(spark, odd):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "only three words"), (1, item)], "item_id long, text string")
    near = item.replace("q27", "new")
    docs = odd.union(spark.createDataFrame([(20, f"x y z {item} tail", "en", "s", 1), (21, near, "en", "s", 1), (22, "Only three WORDS!", "en", "s", 1), (23, "say only three words here", "en", "s", 1), (24, LONG + " " + item.upper(), "en", "s", 1)], DOCS))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.decontaminate(clash(docs, "w", "k", "start", "size"), bench).collect()}
    assert set(got) >= {(20, 1), (21, 1), (22, 4), (24, 1)} and (23, 4) not in got and got[21, 1].similarity < 1 and got[20, 1].start == 3 and got[20, 1].similarity == 1
    assert all(r.distance <= decontaminate.RADIUS and r.similarity >= 0.8 for r in got.values())
    assert decontaminate.without_benchmark(docs, bench).where("doc_id in (20, 24)").count() == 0 and decontaminate.without_benchmark(docs, bench).where("doc_id is null").count() == 1
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == decontaminate.decontaminate(docs, bench.limit(0)).count() == 0


def test_edited_passages_against_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [[f"v{x}" for x in rng.integers(0, 10**6, 30)] for _ in range(40)]
    texts = []
    for i in range(400):
        w = list(items[i % 40])
        w[int(rng.integers(1, 4))] = f"e{i}"
        texts.append(w)

    def cosine(a, b):
        va, vb = ({tuple(w[j : j + 5]): sum(map(len, w[j : j + 5])) for j in range(26)} for w in (a, b))
        norm = lambda v: sum(x * x for x in v.values()) ** 0.5
        return sum(x * vb.get(k, 0) for k, x in va.items()) / norm(va) / norm(vb)

    want = {(i, i % 40) for i, w in enumerate(texts) if cosine(w, items[i % 40]) >= 0.8}
    docs = spark.createDataFrame([(i, "zz yy " + " ".join(w) + " xx") for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(docs, bench).collect()}
    # a fingerprint within the radius is certain for 99 of 100 pairs at the threshold, and no pair under it is reported
    assert len(want) > 300 and got <= want and len(got) >= 0.99 * len(want)


def test_blocks_meet_within_the_radius(spark):
    """Every pair within the radius is found by the index once, and no other."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        x = int(rng.integers(-(2**63), 2**63 - 1))
        y = x
        for b in rng.choice(64, int(rng.integers(0, decontaminate.RADIUS + 4)), replace=False):
            y ^= 1 << int(b) if b < 63 else -(1 << 63)
        rows.append((i, i % 7, x, y))
    windows = spark.createDataFrame([(i, s, x) for i, s, x, _ in rows], "window long, size int, mark long")
    items = spark.createDataFrame([(i, s, y) for i, s, _, y in rows[:60]], "item long, size int, imark long")
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = sorted((i, j, apart(x, y)) for i, s, x, _ in rows for j, t, _, y in rows[:60] if s == t and apart(x, y) <= decontaminate.RADIUS)
    got = decontaminate.near_marks(windows, items, decontaminate.RADIUS).select("window", "item", "distance").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 40
    assert sum(decontaminate.allowances(decontaminate.RADIUS)) + decontaminate.BLOCKS == decontaminate.RADIUS + 1


def test_many_windows_and_places(spark, monkeypatch):
    """Parts of the benchmark's shingles and the way without broadcasts give the same; of equal windows the earlier is reported."""
    items = [" ".join(f"i{j}w{x}" for x in range(20 + j)) for j in range(9)]
    docs = spark.createDataFrame([(i, f"a{i} {items[i % 9]} between {items[i % 9]} z") for i in range(40)], "doc_id long, text string")
    docs = docs.union(docs)
    bench = spark.createDataFrame(list(enumerate(items)) + [(100, items[0])], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect()))
    assert len(want) == 45 and all(r[2] == 2 and r[3] == 1 for r in want)
    for name in ("PLACE_ROWS", "WINDOW_ROWS", "PAIR_ROWS"):
        monkeypatch.setattr(decontaminate, name, 30)
    assert sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect())) == want


def test_long_items(spark):
    """A very long item costs in proportion to its length."""
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + LONG), (2, "short " * 30)], "doc_id long, text string")
    assert [(r.doc_id, r.similarity) for r in decontaminate.decontaminate(docs, bench).collect()] == [(1, 1.0)]


def test_toxicity(spark, odd):
    texts = [(i, "you idiot and moron" if i % 4 == 0 else f"fine words here {i}", "en", "s", 1) for i in range(300, 600)]
    docs = odd.union(spark.createDataFrame(texts, DOCS))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300, 600)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in model.score(clash(docs, "score", "prediction", "probability", "rawPrediction", "insults", "_features")).collect()}
    assert got[300] > 0.8 and got[301] < 0.2 and all(0 <= s <= 1 for s in got.values()) and got[3] == got[4] == got[2]
    assert toxicity.fit(docs, labels.where("toxic = 1")).score(docs).first().score == 1.0 and toxicity.fit(docs, labels.limit(0)).score(docs).first().score == 0.0
    assert model.score(docs.limit(0)).count() == 0


def test_packing(spark, odd):
    rows = clash(spark.createDataFrame([(i, 600, "a" if i % 2 else None, i // 4) for i in range(40)] + [(100, 5000, "b", None), (101, 0, "c", None), (102, None, "c", None), (101, 0, "c", None)], "doc_id long, length int, source string, cluster long"), "bin_id", "shard", "piece")
    got = packing.pack_documents(rows, capacity=2048, shard_rows=1000).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 100] == [2048, 2048, 904] and sum(r.doc_id == 101 for r in got) == 2
    src = {i: i % 2 for i in range(40)}
    for b in {r.bin_id for r in got}:
        held = [r.doc_id for r in got if r.bin_id == b and r.doc_id < 40]
        assert len({src[i] for i in held}) == len(held) == len({i // 4 for i in held})
    assert packing.pack_documents(rows.limit(0)).count() == 0
    # thousands of equal rows are dealt to all shards
    same = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(10).alias("length"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("cluster"))
    shards = [r["count"] for r in packing.pack_documents(same, shard_rows=500).groupBy((F.col("bin_id") / 2**32).cast("int")).count().collect()]
    assert len(shards) == 8 and max(shards) < 700
    with pytest.raises(ValueError):
        packing.pack_documents(rows, capacity=0)


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(9)
    need, source, cluster = np.sort(rng.integers(1, 100, 400))[::-1], rng.integers(0, 70, 400), rng.integers(-1, 90, 400)
    bins = []
    for n, s, c in zip(need, source, cluster, strict=True):
        fit = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n and s not in b[1] and (c < 0 or c not in b[2])]
        if not fit:
            bins.append([100, set(), set()])
            fit = [(100, len(bins) - 1)]
        b = bins[min(fit)[1]]
        b[0] -= n
        b[1].add(s), b[2].add(c)
    got, _ = packing.best_fit(need, source, cluster, 100)
    assert sorted(np.bincount(got, need).astype(int)) == sorted(100 - b[0] for b in bins)


def test_calibration_is_the_piecewise_map(spark):
    knots = [(-1.0, 0.0), (0.0, 0.25), (0.0, 0.5), (2.0, 1.0)]
    x = [-5.0, -1.0, -0.5, 0.0, 1.0, 2.0, 9.0]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(toxicity.calibrated(F.col("x"), knots).alias("y")).collect()]
    assert got == [0.0, 0.0, 0.125, 0.5, 0.75, 1.0, 1.0]
    many = [(i / 500, i / 50_000) for i in range(50_000)]
    assert spark.range(1).select(toxicity.calibrated(F.lit(50.0), many).alias("y")).first().y == pytest.approx(0.5)


def test_pipeline_decisions(spark, tmp_path):
    """What each stage takes away, on rows made for it; ids repeat, with equal and with different texts."""
    import corpus_pipeline

    rng = np.random.default_rng(1)
    words = {"en": EN.split(), "de": DE.split()}
    text = lambda lang, i: " ".join(f"{words[lang][int(k)]} x{i}y{j}" for j, k in enumerate(rng.integers(0, 8, 60)))
    rows = [(i, text("en" if i % 2 else "de", i), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(60)]
    item = " ".join(f"q{i}" for i in range(30))
    near = rows[7][1] + " tail"
    rows += [(70, "123 456", "en", "s1", 1), (71, near, "en", "s2", 1), (72, rows[9][1] + " " + item, "en", "s1", 1), (3, rows[3][1], "en", "s0", 1), (73, None, "en", "s1", 1)]
    rows += [(100 + i, f"FRAME LINE\n{text('en', 100 + i)}", "en", "s9", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, texts = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r.doc_id for r in docs.collect())
        if name == "line_dedup":
            texts = {r.doc_id: r for r in docs.collect()}
    assert 70 not in kept["language_id"] and 73 not in kept["language_id"] and len(kept["language_id"]) == 60 + 3 + 8
    assert not any("FRAME" in r.text for r in texts.values()) and texts[100].n_chars == len(texts[100].text)
    assert kept["near_dedup"] == sorted(set(kept["language_id"]) - {71})
    assert 72 not in kept["decontamination"] and set(kept["packing"]) == set(kept["decontamination"])


def test_pipeline(spark, odd, tmp_path, data):
    import corpus_pipeline

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == odd.columns
        docs = out
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
