import math
import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import cotrain

from .helpers import ODD_TEXTS, babble, documents


def corpus(spark, n=900):
    pick = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = pick.random() < 0.7
        words = babble(i, 60).split()
        if not good and pick.random() < 0.8:
            words = [w + "###" for w in words]
        source = "forge" if not good and pick.random() < 0.7 else f"site{pick.randrange(5)}"
        rows.append((i, " ".join(words), "en", source, len(words)))
        if i % 3:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_scores_all_and_agrees_with_labels(spark):
    docs, labels = corpus(spark)
    rows = {r.doc_id: r for r in cotrain.digest(cotrain.score(docs, cotrain.train(docs, labels))).collect()}
    assert len(rows) == 900 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = np.mean([rows[i].predicted == q for i, q in truth.items()])
    assert right >= 0.9
    views = [np.mean([(getattr(rows[i], v) >= 0.5) == q for i, q in truth.items()]) for v in ("content_score", "metadata_score")]
    assert right >= max(views) - 0.02


def brute(docs, labels, held):
    """Co-training over plain arrays: ids, and scores of all documents."""
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    x = [np.array([cotrain.content(r.text, {}) for r in rows]).astype(np.float16).astype(np.float32), np.array([cotrain.metadata(r.lang, r.source, r.n_chars) for r in rows])]
    y = np.array([quality.get(r.doc_id, -1) for r in rows])
    out = np.array([held[r.doc_id] for r in rows])
    fit, unlabelled = (y >= 0) & ~out, y < 0
    train = [[(x[v][fit], y[fit])] for v in (0, 1)]
    models = lambda: [cotrain.Logistic().fit(np.concatenate([a for a, _ in t]), np.concatenate([b for _, b in t])) for t in train]
    now, free, k = models(), unlabelled.copy(), int(cotrain.CONFIDENT * unlabelled.sum())
    n_low = max(1, round(k * (1 - y[fit].mean())))
    for _ in range(cotrain.ROUNDS):
        takes = []
        for v in (0, 1):
            cell = np.floor(now[v].logits(x[v]) * cotrain.BINS)
            below, above = np.sort(cell[free & (cell < 0)]), np.sort(cell[free & (cell >= 0)])[::-1]
            low = below[min(n_low, len(below)) - 1] if len(below) else -np.inf
            high = above[min(max(1, k - n_low), len(above)) - 1] if len(above) else np.inf
            takes.append((free & (cell <= low), free & (cell >= high)))
        for v, (zeros, ones) in enumerate(takes):
            train[1 - v].append((x[1 - v][zeros | ones], ones[zeros | ones].astype(int)))
            free &= ~(zeros | ones)
        now = models()
    target = y[(y >= 0) & out]
    z = [m.logits(v)[:, None] for m, v in zip(now, x)]
    z = np.stack([cotrain.Logistic().fit(a[(y >= 0) & out], target).logits(a) for a in z], axis=1)
    return 1 / (1 + np.exp(-cotrain.Logistic().fit(z[(y >= 0) & out], target).logits(z)))


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cotrain, "CONFIDENT", 0.05)
    docs, labels = corpus(spark)
    labels = labels.unionByName(labels.select((F.col("doc_id") + 5000).alias("doc_id"), "quality"))  # labels without documents
    rows = cotrain.labelled(cotrain.features(docs), labels)
    held = {r.id: r.held for r in rows.select("id", "held").collect()}
    got = {r.doc_id: r.score for r in cotrain.classified(docs.repartition(5), labels).collect()}
    assert np.allclose([got[i] for i in sorted(got)], brute(docs, labels, held), atol=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    few = labels.filter("doc_id % 2 = 0")
    got = {r.doc_id: r.predicted for r in cotrain.digest(cotrain.classified(docs, few)).collect()}
    rest = labels.filter("doc_id % 2 = 1").collect()
    assert np.mean([got[r.doc_id] == r.quality for r in rest]) >= 0.85


def test_thresholds_take_whole_bins_on_their_own_side():
    assert cotrain.thresholds({-9: 3, -5: 4, 2: 5, 8: 1}, 4, 1) == (-5, 8)
    assert cotrain.thresholds({-1: 2}, 5, 5) == (-1, math.inf) and cotrain.thresholds({}, 1, 1) == (-math.inf, math.inf)


def test_odd_rows(spark):
    docs, labels = corpus(spark, 300)
    model = cotrain.train(docs, labels)
    odd = documents(spark, ODD_TEXTS)
    rows = cotrain.score(odd, model).collect()
    assert len(rows) == len(ODD_TEXTS) and not any(np.isnan(r.score) for r in rows)
    assert cotrain.train(docs, labels.limit(0)).constant == 1.0 and cotrain.train(docs.limit(0), labels).constant is not None
    assert cotrain.train(docs, labels.filter("quality = 1")).constant == 1.0
    assert cotrain.score(docs.limit(0), model).count() == 0
    nameless = spark.createDataFrame([(None, "a", None, None, None)] * 3 + [(1, None, "en", "s", -5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert cotrain.classified(nameless, labels).count() == 4


def test_full_memo_loses_no_words():
    memo = {f"w{i}": cotrain._bin(f"w{i}", cotrain.WORD_BINS) for i in range(cotrain.MEMO)}
    for text in ("w1 " * 500 + "new words that fill it", " ".join(f"k{i}" for i in range(cotrain.MEMO + 500))):
        assert np.array_equal(cotrain.content(text, memo), cotrain.content(text, {}))


def test_digits_by_one_rule_at_every_length():
    short, long = "\u0663\u0664 12 ab " * 4, "\u0663\u0664 12 ab " * 10_000
    assert cotrain.content(short, {})[9] == cotrain.content(long, {})[9] == np.float32(4 / 9)
