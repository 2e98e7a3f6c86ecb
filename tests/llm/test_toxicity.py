import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity

from .helpers import ODD_TEXTS, babble, documents


def corpus(spark, n=600):
    pick = random.Random(7)
    texts, labels = [], []
    for i in range(n):
        words = babble(i, 60).split()
        bad = i % 4 == 0
        for _ in range(5 if bad else 0):
            words.insert(pick.randrange(len(words)), pick.choice(["vileword", "nastyterm", "foulishness"]) + pick.choice(["", "ly", "ed"]))
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus(spark)
    rows = toxicity.digest(toxicity.score(docs, toxicity.train(docs, labels))).join(labels, "doc_id").collect()
    assert len(rows) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)


def test_labels_lang_source_and_ids_do_not_enter(spark):
    docs, labels = corpus(spark, 300)
    model = toxicity.train(docs, labels)
    other = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("s").alias("source"))
    a = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    b = {r.doc_id - 10_000: r.score for r in toxicity.score(other, model).collect()}
    assert a == b


def test_ratios_match_brute_force(spark):
    docs, labels = corpus(spark, 60)
    grams = toxicity.checkpointed(toxicity.count_n_grams(toxicity.training_rows(docs, labels, "doc_id", "text")).filter("gram != ''"))
    low = {r.low: r.p_low for r in toxicity.shared_backoff(grams).collect()}
    discount = toxicity.discounts(grams)
    by_gram, by_context = toxicity.ratios(grams, toxicity.shared_backoff(grams), discount)
    counts = [Counter(), Counter()]
    train = docs.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    for r in train.collect():
        for w in toxicity.words_of(r.text):
            t = "\x02" * 4 + w + "\x03"
            counts[r.toxic].update(t[i : i + 5] for i in range(len(t) - 4))
    weights = []
    for x, c in enumerate(counts):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(k, max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.75 * k for k in (1, 2, 3)]
        assert discount[f"{x}_both"] == pytest.approx(d)
        off, den, mass = {g: d[min(k, 3) - 1] for g, k in c.items()}, Counter(), Counter()
        for g, k in c.items():
            den[g[:4]] += k
            mass[g[:4]] += off[g]
        weights.append((c, off, den, mass))

    def p(g, c, off, den, mass):
        ctx = g[:4]
        return ((c[g] - off.get(g, 0)) + mass[ctx] * low[g[1:]]) / den[ctx] if den[ctx] else low[g[1:]]

    for r in by_gram.collect():
        assert r.r_both == pytest.approx(math.log(p(r.gram, *weights[1]) / p(r.gram, *weights[0])), abs=1e-9)
    for r in by_context.collect():
        back = [mass[r.gram] / den[r.gram] if den[r.gram] else 1.0 for _, _, den, mass in weights]
        assert r.r_both == pytest.approx(math.log(back[1] / back[0]), abs=1e-9)
    sums = Counter()
    for g, p in low.items():
        sums[g[:3]] += p
    assert all(0 < v <= 1 + 1e-9 for v in sums.values())  # the rest is what unseen continuations get


def test_nothing_is_learned_from_held_out_labels(spark):
    docs, _ = corpus(spark, 90)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(90)]
    labels = spark.createDataFrame([(i, int(h)) for i, h in enumerate(held)] + [(1000 + i, 1) for i in range(90)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).constant == 0.0
    flipped = labels.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("doc_id") % 2).cast("int").alias("toxic"))
    kept = flipped.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    scores = [{r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, x)).collect()} for x in (flipped, kept)]
    assert len(scores[0]) == 90 and scores[0] == pytest.approx(scores[1])


def test_odd_rows(spark):
    docs, labels = corpus(spark, 120)
    model = toxicity.train(docs, labels)
    odd = documents(spark, ODD_TEXTS)
    scores = [r.score for r in toxicity.score(odd, model).orderBy("doc_id").collect()]
    assert len(scores) == len(ODD_TEXTS) and scores[0] == scores[1] == scores[2] and not any(np.isnan(scores))
    kept = toxicity.filter_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD_TEXTS)
    assert toxicity.train(docs, labels.limit(0)).constant == 0 and toxicity.train(docs.limit(0), labels).constant is not None
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_no_two_n_grams_share_a_ratio(spark):
    pick = random.Random(3)
    letters = [chr(c) for c in [*range(97, 123), *range(0x430, 0x450)]]
    word = lambda: "".join(pick.choices(letters, k=8))
    docs = documents(spark, [" ".join(word() for _ in range(400)) for _ in range(120)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    grams = toxicity.checkpointed(toxicity.count_n_grams(toxicity.training_rows(docs, labels, "doc_id", "text")).filter("gram != ''"))
    both = toxicity.ratios(grams, toxicity.shared_backoff(grams), toxicity.discounts(grams))
    by_gram, by_context = ({r.gram: r.r_both for r in t.collect()} for t in both)
    assert len(by_gram) > 200_000
    known = sorted({w for r in docs.limit(40).collect() for w in r.text.split()})
    words = known + [word() for _ in range(5000)]
    want = []
    for w in words:
        t = "\x02" * 4 + w + "\x03"
        want.append(sum(by_gram.get(t[i : i + 5], min(0.0, by_context.get(t[i : i + 4], 0.0))) for i in range(len(t) - 4)))
    assert np.allclose(toxicity.word_ratios(words, *model.tables.value), want, atol=1e-4)


def test_tables_in_pieces_give_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", 20)  # so that most words are joined
    docs, labels = corpus(spark, 300)
    docs = docs.unionByName(docs.limit(5)).unionByName(documents(spark, ODD_TEXTS).withColumn("doc_id", F.col("doc_id") + 5000))
    whole, cut = toxicity.train(docs, labels), toxicity.train(docs, labels, piece=40)
    assert isinstance(cut.tables, toxicity.Pieces) and cut.tables.number > 2
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(docs, m).collect()) for m in (whole, cut))
    assert [i for i, _ in a] == [i for i, _ in b] and len(a) == 305 + len(ODD_TEXTS)
    assert np.allclose([s for _, s in a], [s for _, s in b], atol=1e-4)
    clash = docs.withColumn("__rejected", F.lit("x")).withColumn("tag", F.lit(1))
    kept = [toxicity.filter_toxic(clash, m) for m in (whole, cut)]
    assert kept[1].columns == clash.columns
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert ids[0] == ids[1] and 0 < len(ids[0]) < len(a)
    assert toxicity.score(docs.limit(0), cut).count() == 0 and toxicity.filter_toxic(docs.limit(0), cut).count() == 0
