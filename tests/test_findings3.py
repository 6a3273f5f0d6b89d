"""Cases of the third round's findings."""

import datetime as dt
import os
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from taxloom.llm import crf_langid, order_minhash
from taxloom.plans import registry

QUERIES = registry.queries()


def test_alerts_of_each_user(spark, data, tmp_path):
    """users are judged alone, not only together: two failures of one user in a slot are an alert, those of two users aren't."""
    at = dt.datetime(2024, 1, 1, 10, 1)
    later = lambda minutes: at + dt.timedelta(minutes=minutes)
    rows = [(1, later(0), 7, "error"), (2, later(5), 7, "error"), (3, later(20), 8, "error"), (4, later(25), 9, "error")]
    rows += [(10 + i, later(60 + i), 7, "view") for i in range(3)] + [(20 + i, later(120 + i), 5, "purchase") for i in range(5)]
    events = spark.createDataFrame([(*r, 0.0, "") for r in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    for table in ("customer", "orders", "lineitem"):
        os.symlink(f"{data}/{table}.parquet", f"{tmp_path}/{table}.parquet")
    slot = lambda minutes, seconds: int(later(minutes).replace(tzinfo=dt.UTC).timestamp()) // seconds * seconds
    got = Counter(tuple(r) for r in QUERIES["agg_alerts"](spark, str(tmp_path)).select("rule", "slot", "actor", "n").collect())
    assert got == Counter([("failures", slot(0, 900), 7, 2), ("views", slot(60, 3600), 7, 3), ("purchases", slot(120, 3600), 5, 5), ("all_deletions", slot(120, 3600), 0, 5)])


def test_language_of_many_long_texts_in_bounded_memory(monkeypatch):
    """The pipeline's first stage: a batch's words and their numbers aren't held, however many texts it has."""
    monkeypatch.setattr(crf_langid, "CELLS", 1 << 12)
    monkeypatch.setattr(crf_langid, "SLICE", 1 << 13, raising=False)
    model = crf_langid.Crf(["a", "b"], np.random.default_rng(1).normal(size=(crf_langid.SLOTS, 2)).astype(np.float32), np.eye(2))
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(200))
    want = model.predict([text])
    tracemalloc.start()
    langs, scores, others = model.predict([text, None, *[text] * 2_000])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1e6, most
    assert langs == [*want[0], crf_langid.UNKNOWN, *want[0] * 2_000] and others == [*want[2], 0, *want[2] * 2_000]
    assert np.allclose(scores, [*want[1], 0.0, *want[1] * 2_000])


def test_sample_texts_are_split_in_one_worker_a_task(spark):
    """The pipeline's first stage: words of the sample are found once, so a task holds one Python worker; the stretches are those of each text."""
    texts = [" ".join(f"{chr(97 + i)}{chr(97 + j % 26)}" for j in range(n)) for i, n in enumerate((1, 47, 48, 49, 100))]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, "", "12 ?", None])] + [(90, "no language", None)], "doc_id long, text string, lang string")
    drawn = crf_langid.sample(rows)
    assert drawn._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    words = [t.split() for t in texts]
    assert Counter((tuple(r.words), r.lang) for r in drawn.collect()) == Counter((tuple(w[i : i + 48]), "en") for w in words for i in range(0, len(w), 48))


def test_sketches_are_those_of_each_text():
    """Arrow arrays with an offset, empty texts, and texts of both kinds of sketch."""
    words = [np.arange(n, dtype=np.int32) * 7919 for n in (3, 0, 21, 27, 400, 9_000)]
    whole = pa.array([np.ones(5, np.int32), *words], pa.list_(pa.int32()))
    got = order_minhash._sketch_all(whole[1:]).to_pylist()
    for w, keys in zip(words, got, strict=True):
        with np.errstate(over="ignore"):
            k = order_minhash.labelled_kmers(w)
            kinds = [t for t, fits in ((order_minhash.TAKE, len(k) >= 20), (order_minhash.TAKE_SHORT, 0 < len(k) <= 24)) if fits]
            assert keys == [x for t in kinds for x in order_minhash.sketches(k, t).view(np.int64).tolist()]
