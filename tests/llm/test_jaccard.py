import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import graph, jaccard

from .helpers import ODD_TEXTS, babble, documents, real_texts


def shingle_set(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(texts, size=4, percent=85):
    sets = [shingle_set(t, size) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def mutated(text, edits, seed):
    pick = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
    return " ".join(words)


def case():
    texts = []
    for k in range(12):
        base = babble(k, 150)
        texts += [mutated(base, e, 100 * k + e) for e in (0, 1, 2, 3, 4, 5, 6, 8)]
    hub = babble(77, 120)
    texts += [mutated(hub, 2, s) for s in range(90)]  # a group whose copies link through a few of them
    texts += [hub, hub, hub.upper(), hub + " and more"]
    passage = babble(5000, 40)
    texts += [babble(600 + s, 30) + " " + passage for s in range(60)]  # a passage that does not make them alike
    chain = babble(888, 200).split()
    texts += [" ".join(chain[4 * s : 4 * s + 100]) for s in range(20)]
    return texts + ODD_TEXTS + ["a b", "A B", "a b c d", "a b c d e"]


def test_components_match_brute_force(spark, monkeypatch):
    texts = case() + real_texts(spark, 80)
    want = brute(texts)
    for frequent in (jaccard.FREQUENT, 1000):
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        got = sorted(tuple(r) for r in jaccard.join(documents(spark, texts)).collect())
        assert got == want
    assert len({c for _, _, c in want}) < len(texts) - 100


def test_hot_runs_lose_nothing(spark, monkeypatch):
    texts = case()
    want = brute(texts)
    for run, block, rounds in ((4, 8, 0), (16, 512, 1), (1, 3, 0)):
        monkeypatch.setattr(jaccard, "HOT_RUN", run)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        assert sorted(tuple(r) for r in jaccard.join(documents(spark, texts)).collect()) == want


def test_few_pairs_in_a_group_of_near_copies(spark):
    hub = babble(77, 300)
    docs = documents(spark, [mutated(hub, 3, s) for s in range(300)])
    order = spark.sparkContext.broadcast(jaccard.frequent(docs, "doc_id", "text", 4))
    rows = jaccard.records(docs, order, "doc_id", "text", 4, 85)
    shared = jaccard.first_pairs(rows.select(F.explode("prefix").alias("token"), "n", "class"), 85)
    pairs = shared.select("class", F.explode(F.array("by_size", "by_head", "by_least")).alias("b")).filter("class != b").distinct()
    assert pairs.count() < 300 * 60


def test_nulls_repeats_and_empty(spark):
    text = babble(1, 50)
    docs = spark.createDataFrame([(None, text, 1), (7, text, 2), (5, text + " x", 3), (7, "other words stand here now", 4), (9, None, 5)], "doc_id long, text string, component_id int")
    got = {(r.doc_id, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == {(None, None), (7, 5), (5, 5), (7, 7), (9, 9)}
    assert jaccard.join(docs.limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    texts = case()
    docs = documents(spark, texts)
    kept = jaccard.deduplicate(docs.unionByName(docs.filter("doc_id % 7 = 0")))
    assert kept.columns == docs.columns
    want = sorted([i for i, n, c in brute(texts) if i == c and n] + [i for i, n, c in brute(texts) if not n] + [i for i, n, c in brute(texts) if not n and i % 7 == 0])
    assert sorted(r.doc_id for r in kept.collect()) == want
    odd = spark.createDataFrame([(None, babble(1, 50)), (None, babble(1, 50)), (7, babble(1, 50)), (7, babble(2, 50)), (8, babble(2, 50)), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in jaccard.deduplicate(odd).collect()) == sorted([(0, babble(1, 50)), (0, babble(1, 50)), (7, babble(1, 50)), (7, babble(2, 50)), (9, "")])


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000 - i, 999 - i) for i in range(200)] + [(5000, 5001), (5002, 5001)]
    random.Random(3).shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = {i: 0 for i in range(1, 401)} | {i: 800 for i in range(801, 1001)} | {5001: 5000, 5002: 5000}
    for finish in (0, 3, 1 << 19):  # by rounds alone, by rounds and a last task, by the last task
        rows = graph.components(frame, finish).collect()
        assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_of_one_structure_are_told_apart(spark):
    turn = str.maketrans("ab", "ba")
    word = "ab"
    while len(word) < 4096:
        word += word.translate(turn)  # polynomials modulo 2^64 do not tell these two apart
    docs = documents(spark, [word, word.translate(turn)])
    assert sorted(tuple(r) for r in jaccard.join(docs).collect()) == [(0, 1, 0), (1, 1, 1)]


def test_long_runs_are_cut_into_stretches(spark):
    docs = documents(spark, [f"alpha beta gamma delta w{s} x{s}" for s in range(400)])
    order = spark.sparkContext.broadcast((jaccard.np.zeros(0, "uint64"), jaccard.np.zeros(0, "int64")))
    rows = jaccard.records(docs, order, "doc_id", "text", 4, 10)
    found = jaccard.first_pairs(rows.select(F.explode("prefix").alias("token"), "n", "class"), 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = found.select("token", F.spark_partition_id().alias("task")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = Counter(r.token for r in rows).most_common(1)[0]
    assert hot[1] == 400 and len({r.task for r in rows if r.token == hot[0]}) > 1


def test_deduplicate_with_clashing_names_and_ties(spark):
    text = babble(1, 50)
    rows = [(7, text, "b", 1), (7, text, None, 2), (7, text, "a", 3), (8, text + " x", "c", 4), (9, None, "d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __tag string, __head_id int")
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(7, text, None, 2), (9, None, "d", 5)]
