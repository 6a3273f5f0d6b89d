"""Registered queries of the training-data operators: SQL, held-out quality, and brute force at the smallest size."""

import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import same_rows

from taxloom.llm import queries as q

SQL = q.oracle_sql()


@pytest.fixture(scope="module")
def docs(duck):
    return {i: (t, lang) for i, t, lang in duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, data, name):
    same_rows(q.queries()[name](spark, data), duck, SQL[name])


def test_token_totals(spark, duck, docs, data):
    """Totals by (source, lang, tokenizer) equal a recount of what the batches leave."""
    from taxloom.llm.token_ledger import PATTERN, VOCABULARY, _encoding

    enc = _encoding(VOCABULARY, PATTERN)
    seen, want = set(), defaultdict(lambda: np.zeros(3, int))
    source = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    for i in sorted(docs):
        t, lang = docs[i]
        if t in seen:
            continue
        seen.add(t)
        if "Licensed under" in t:
            t = "\n".join(x for x in t.split("\n") if not x.startswith("Licensed under"))
        want[source[i], lang, "byte_bpe_50k"] += (1, len(enc.encode_ordinary(t)), len(t))
    rows = q.op2_token_ledger(spark, data).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in rows} == {k: tuple(v.tolist()) for k, v in want.items()}


def test_near_duplicates_equal_brute_force(spark, docs, data):
    norm = {i: re.sub(r"\s+", " ", t.lower()).strip().split(" ") for i, (t, _) in docs.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in norm.items()}
    got = {r.doc_id: r.class_id for r in q.op3_order_minhash(spark, data).collect()}
    assert set(got) == set(docs)
    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.82:
                assert got[a] == got[b]
            if j < 0.5:
                assert got[a] != got[b] or any(got[c] == got[a] for c in ids if c not in (a, b))


def test_decontamination_finds_every_passage(spark, duck, docs, data):
    words = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) + " "
    items = {i: words(t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()}
    want = {(d, i) for d, (t, _) in docs.items() for i, w in items.items() if w in words(t)}
    got = {(r.doc_id, r.item_id) for r in q.op8_decontaminate(spark, data).collect()}
    assert want <= got and want


def test_language_of_held_out_documents(spark, docs, data):
    rows = q.op5_crf_langid(spark, data).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id][1] for r in held]) >= 0.97


def test_the_method_blocks_and_allows_hosts_without_rules(spark, data):
    """Verdicts of pages without a rule come from their hosts' posteriors: hosts of spam with enough pages are blocked, hosts of some junk are not."""
    data = str(Path(data).parent / "sf0.01")
    rows = [r for r in q.op4_url_reputation(spark, data).collect() if r.rule is None]
    verdicts = defaultdict(set)
    for r in rows:
        verdicts[r.host].add(r.verdict)
    assert all(len(v) == 1 for v in verdicts.values()) and {"allow", "block"} == {r.verdict for r in rows}
    blocked = {h for h, v in verdicts.items() if v == {"block"}}
    assert all(set(re.split("[^a-z]", h)) & set(q.SPAM) for h in blocked) and len(blocked) < len(verdicts) / 4
    junk = {r.page_id for r in q.page_outcomes(spark, data).where("bad = 1").collect()}
    assert any(r.verdict == "allow" and r.page_id in junk for r in rows)


def test_toxicity_ranks_held_out_documents(spark, duck, data):
    data = str(Path(data).parent / "sf0.01")  # the smallest tables hold two toxic documents out
    rows = {r.doc_id: r for r in q.op9_toxicity(spark, data).collect()}
    toxic = dict(duck.execute(f"SELECT doc_id, toxic FROM '{data}/labels.parquet'").fetchall())
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    one, none = ([rows[i].score for i, t in toxic.items() if t == k and rows[i].held_out] for k in (1, 0))
    assert min(len(one), len(none)) >= 3
    assert np.mean([(a > b) + (a == b) / 2 for a in one for b in none]) >= 0.8


def test_packing_holds_its_constraints(spark, docs, data):
    rows = q.op10_packing(spark, data).collect()
    source = {r.doc_id: (r.source, r.cluster) for r in q.packing_input(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    bins, words = defaultdict(list), defaultdict(int)
    for r in rows:
        bins[r.bin_id].append(r)
        words[r.doc_id] += r.n_tokens
    assert words == {i: len(t.split()) for i, (t, _) in docs.items()}
    # one shard here: the query's bins are those of a plain search, longest first, for the fullest bin that fits
    plain, spare = [], defaultdict(list)
    for d, (s, c) in source.items():
        for at in range(0, max(1, words[d]), 2048):
            spare[min(2048, words[d] - at)].append((d, s, c))
    for n in sorted(spare, reverse=True):
        for _, s, c in sorted(spare[n], key=lambda x: x[0]):
            fit = [(b[0], i) for i, b in enumerate(plain) if b[0] >= n and s not in b[1] and c not in b[2]] if n < 2048 else []
            if not fit:
                plain.append([2048, set(), set()])
                fit = [(2048, len(plain) - 1)]
            b = plain[min(fit)[1]]
            b[0] -= n
            b[1].add(s), b[2].update({c} - {None})
    assert len(bins) == len(plain) and sorted(sum(r.n_tokens for r in x) for x in bins.values()) == sorted(2048 - b[0] for b in plain)
    for held in bins.values():
        end = 0
        for r in sorted(held, key=lambda r: (r.bin_offset, r.n_tokens)):
            assert r.bin_offset == end
            end += r.n_tokens
        assert end <= 2048
        for k in (0, 1):
            keys = [source[r.doc_id][k] for r in held if source[r.doc_id][k] is not None]
            assert len(keys) == len(set(keys))


def test_registered(spark, data):
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in e.queries()} and "pipeline" in e.queries()
