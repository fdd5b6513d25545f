import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightjar.llm import cotrain as ct

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"
LABELS = "doc_id long, quality int"
GOOD = ["the river runs past the old mill", "people walk along the bank", "a boat waits there", "rain fell in the night"]
BAD = ["BUY NOW!!!", "click $$$ here", "||| menu ||| home", "free @@@ offer!!"]


def sample(n=240):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 2 == 0
        text = ". ".join(rng.choice(GOOD if good else BAD) for _ in range(rng.randrange(3, 12)))
        rows.append((i, text, "en", "press" if good else "spam", len(text), "clash", "clash"))
        if i < n // 2:
            labels.append((i, int(good)))
    return rows, labels


def fitted(spark, rows, labels, **limits):
    return ct.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), **limits)


def test_unlabelled_documents_are_told_apart(spark):
    rows, labels = sample()
    got = fitted(spark, rows, labels)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() == len(rows)
    out = {r.doc_id: r for r in got.collect()}
    right = [out[i].kept == (i % 2 == 0) for i in range(120, 240)]
    assert np.mean(right) >= 0.98
    assert all(0 <= r[c] <= 1 for r in out.values() for c in ("text_score", "meta_score", "score"))


def test_words_alone_teach_the_text_view(spark):
    """Both classes have the same shape, length, source and signs; only their words differ."""
    rng = random.Random(6)
    words = {True: [f"kal{i}o" for i in range(60)], False: [f"bem{i}u" for i in range(60)]}
    rows = [(i, " ".join(rng.choice(words[i % 2 == 0]) for _ in range(20)), "en", "s", 5, "", "") for i in range(400)]
    got = fitted(spark, rows, [(i, int(i % 2 == 0)) for i in range(200)]).collect()
    assert np.mean([r.kept == (r.doc_id % 2 == 0) for r in got if r.doc_id >= 200]) >= 0.95


def test_nulls_repeats_ties_long_and_empty_texts(spark):
    rows, labels = sample()
    odd = [(None, None, None, None, None, None, None), (1000, None, None, None, None, None, None), (1001, "", "en", "press", 0, "", ""), (1002, "long words of the river " * 60_000, "en", "press", 9, "", "")]
    odd += [rows[0]] * 3 + [(2, "another text under a known id", "en", "press", 9, "", "")]
    got = fitted(spark, rows + odd, labels + [(3, 0), (3, 0), (None, 1), (5, None)]).collect()
    assert len(got) == len(rows) + len(odd) and all(r.score is not None and r.kept is not None for r in got)
    same = [r.score for r in got if r.doc_id == 0]
    assert len(same) == 4 and len(set(same)) == 1
    again = fitted(spark, (rows + odd)[::-1], (labels + [(3, 0)])[::-1]).collect()
    assert sorted((r.doc_id or -1, round(r.score, 9)) for r in again) == sorted((r.doc_id or -1, round(r.score, 9)) for r in got)


def test_without_both_classes_all_stay(spark):
    rows, labels = sample(40)
    for some in ([], [x for x in labels if x[1] == 1]):
        got = fitted(spark, rows, some).collect()
        assert all(r.kept and r.score is None for r in got) and len(got) == 40
    assert fitted(spark, [], labels).count() == 0


def test_bounds_hold(spark):
    rows, labels = sample()
    got = fitted(spark, rows, labels, labelled=30, pool=10).collect()
    assert np.mean([r.kept == (r.doc_id % 2 == 0) for r in got]) >= 0.95


def test_views_exchange_labels():
    import pandas as pd

    rows, _ = sample(400)
    held = [np.packbits(ct.grams(r[1])).tobytes() for r in rows]
    frame = pd.DataFrame({"t_words": [len(r[1].split()) for r in rows], "m_chars": [r[4] for r in rows], "m_source": [r[3] for r in rows], "m_lang": "en", "g": held, "y": [int(r[0] % 2 == 0) for r in rows]})
    model = ct.co_train(frame[:100].reset_index(drop=True), frame[100:].drop(columns="y").reset_index(drop=True))
    assert min(model.exchanged) > 20


def test_the_fit_holds_little_memory():
    """A feature is a byte in the driver: what the fit holds is a small multiple of the bytes of its rows."""
    import tracemalloc

    import pandas as pd

    draw = np.random.default_rng(3)
    n = 16_000
    y = draw.integers(0, 2, n)
    frame = pd.DataFrame({f"t_{i}": draw.normal(size=n) + y / 2 for i in range(12)} | {"m_chars": draw.normal(size=n) + y, "m_source": np.where(y, "a", "b"), "m_lang": "en"})
    frame["g"] = [bytes(x) for x in draw.integers(0, 256, (n, ct.GRAMS // 8), dtype=np.uint8)]
    known, pool = frame[: n // 2].assign(y=y[: n // 2]), frame[n // 2 :].reset_index(drop=True)
    tracemalloc.start()
    model = ct.co_train(known, pool)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model is not None and peak < 60e6, peak


@pytest.mark.parametrize("fold", [0, 1])
def test_held_out_accuracy(spark, fold):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == fold
    got = ct.classify(docs, labels.filter(~out)).join(labels.filter(out).select("doc_id", "quality"), "doc_id").collect()
    accuracy = np.mean([r.kept == (r.quality == 1) for r in got])
    assert len(got) > 50 and accuracy >= 0.95, accuracy
