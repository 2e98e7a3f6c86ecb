import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import quality

from .helpers import ODD_TEXTS, documents, real_texts


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, n_dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            n_dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeat = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), n_dup, len(repeat), failed


def test_measures_match_brute_force(spark):
    texts = ODD_TEXTS + real_texts(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (999, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.digest(quality.judge(documents(spark, texts), labels)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.1), (20, 1000, 0.03), (900, 100_000, 0.01), (5, 9, 0.9)])
def test_binomial_tail_is_exact(spark, k, n, p):
    got = spark.range(1).select(quality.log_tail(F.lit(float(k)), F.lit(float(n)), p)).head()[0]
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
    top = max(logs)
    assert got == pytest.approx(top + math.log(sum(math.exp(x - top) for x in logs)), rel=1e-7, abs=1e-7)


def test_cutoffs_bound_false_rejection(spark):
    def row(i):
        symbols = 0 if i % 200 else 40  # 1 good document of 200 has many symbols
        return i, " ".join(f"w{i}x{j}" for j in range(100)) + " #" * symbols, "en"

    docs = spark.createDataFrame([row(i) for i in range(4000)] + [(5000, " ".join(f"b{j} #" for j in range(60)), "en"), (5001, " ".join(f"b{j} #" for j in range(60)), None)], "doc_id long, text string, lang string")
    labels = docs.filter("doc_id < 4000").select("doc_id", F.lit(1).alias("quality"))
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert not got[5000] and got[5001]  # no valid cutoff without labels
    assert sum(not got[i] for i in range(4000)) <= 0.05 * 4000
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_windows_of_any_width(spark):
    pick = random.Random(3)
    rows = [(i, [pick.randrange(2 + i % 3) for _ in range(i % 41)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "i long, words array<long>").repartition(4)
    widths = (2, 3, 5, 8)
    for r in frame.select("i", *(quality.repeated_words(F.col("words"), n).alias(f"n{n}") for n in widths)).collect():
        words = rows[r.i][1]
        for n in widths:
            where = {}
            for at in range(len(words) - n + 1):
                where.setdefault(tuple(words[at : at + n]), []).append(at)
            assert r[f"n{n}"] == len({p for at in where.values() if len(at) > 1 for a in at for p in range(a, a + n)}), (words, n)
