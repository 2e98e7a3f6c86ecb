import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import bpe

from .helpers import ODD_TEXTS, documents, real_texts

RANKS = bpe.read_ranks(bpe.default_tokenizer())
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    pick = random.Random(11)
    noise = ["".join(pick.choice("abcéß漢 \n\t'ſtl0½Ⅷ😀_-<|> ​́") for _ in range(pick.randrange(1, 300))) for _ in range(200)]
    return ODD_TEXTS + noise + ["<|endoftext|> it's WE'LL", "ab" * 400, "é" * 300, " " * 5000 + "x", "".join(pick.choice("etaoin") for _ in range(20_000))] + real_texts(spark)


@pytest.mark.parametrize("memo", [bpe.MEMO, 50])
def test_ids_and_round_trip(spark, texts, monkeypatch, memo):
    monkeypatch.setattr(bpe, "MEMO", memo)
    rows = bpe.digest(bpe.encode(documents(spark, texts), decoded=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = ENCODING.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode())), text[:80]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_heap_merges_like_the_library(word):
    assert bpe.merge_long(word, RANKS) == (ENCODING._core_bpe.encode_single_piece(word))


def test_fold_merges_like_the_library(spark):
    pick = random.Random(2)
    words = [bytes(pick.choice(b" theandingtion\xc3\xa9") for _ in range(pick.randrange(1, 40))) for _ in range(400)]
    frame = spark.createDataFrame(list(zip(words, bpe.Handing(RANKS)(words))), "w binary, t string")
    got = frame.withColumn("ranks", bpe.rank_table(spark, RANKS)).select("w", bpe.fold(F.col("t"), F.col("ranks")).alias("t")).collect()
    assert all([ord(c) - ord(bpe.character(0)) for c in r.t] == ENCODING._core_bpe.encode_single_piece(bytes(r.w)) for r in got)


def test_latin_pattern_cuts_like_the_full_one():
    import regex

    full = regex.compile(public_tokenizers.PATTERN)
    assert all(bool(regex.match(rf"[{a}]", c)) == bool(regex.match(b, c)) for c in map(chr, range(0x250)) for a, b in ((bpe._L, r"\p{L}"), (bpe._N, r"\p{N}"), (bpe._S, r"\s")))
    pick = random.Random(8)
    for _ in range(500):
        text = "".join(pick.choice("ab'stl 1²\n\t\x85\xa0\x1c.-éɏ×÷") for _ in range(60))
        assert full.findall(text) == __import__("re").findall(bpe._LATIN, text)


def test_decode_by_expressions(spark, texts):
    rows = bpe.decode(bpe.encode(documents(spark, texts[:100]))).collect()
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in rows)


def test_empty_table(spark):
    assert bpe.digest(bpe.encode(documents(spark, ["a"]).limit(0), decoded=True)).count() == 0


@pytest.fixture
def small_sample(monkeypatch):
    monkeypatch.setattr(bpe, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(bpe, "SAMPLE_CHARS", 10_000)


@pytest.mark.parametrize("size", [bpe.VOCABULARY, 30])
def test_ids_with_a_vocabulary(spark, texts, small_sample, monkeypatch, size):
    monkeypatch.setattr(bpe, "VOCABULARY", size)
    rows = bpe.digest(bpe.encode(documents(spark, texts).repartition(3), decoded=True)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = ENCODING.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode())), text[:80]


def test_words_common_to_tasks_are_folded_once(spark, small_sample):
    common = ["Thntatre lesenre", "zuenung zuenung", "tzkeittz lasdora"]
    rows = spark.createDataFrame([(k, common[k % 3] + (" qxvjkwzrare" if k == 5 else "")) for k in range(400)], "id long, text string").repartition(4)
    handed = [w for r in bpe.numbered_words(rows, bpe.default_tokenizer()).collect() for w in r.words]
    folded = [w for w in handed if len(w) > 1 and not w.startswith(bpe.READY)]
    assert len([w for w in handed if w.startswith(bpe.READY)]) >= 4 and len(folded) <= 1


def test_vocabulary_is_bounded_and_right(spark, texts, small_sample, monkeypatch):
    monkeypatch.setattr(bpe, "VOCABULARY", 25)
    found = bpe.vocabulary(documents(spark, texts).select("text"), bpe.default_tokenizer())
    words = [bytes(w) for w in found.words.to_pylist()]
    assert 0 < len(words) <= 25 and found([b"qxvjkwzrare", b""]) == [None, None]
    for word, tokens in zip(words, found(words)):
        assert [ord(c) - ord(bpe.character(0)) for c in tokens.removeprefix(bpe.READY)] == ENCODING._core_bpe.encode_single_piece(word)


def test_vocabulary_without_words(spark, small_sample):
    rows = bpe.encode(documents(spark, ["a", None, ""] * 30)).collect()
    assert [list(r.ids) for r in sorted(rows, key=lambda r: r.doc_id)] == [ENCODING.encode_ordinary("a"), [], []] * 30


def test_no_task_keeps_two_python_workers(spark, texts):
    plan = bpe.encode(documents(spark, texts))._jdf.queryExecution().executedPlan().toString().splitlines()
    kinds = [kind for line in plan for kind in ("MapInArrow", "Exchange") if kind in line]
    assert kinds[-3:] == ["MapInArrow", "Exchange", "MapInArrow"]


@pytest.mark.parametrize("memo", [bpe.MEMO, 50])
def test_word_lists_of_tasks_that_share_a_partition(spark, texts, monkeypatch, memo):
    monkeypatch.setattr(bpe, "MEMO", memo)
    monkeypatch.setattr(bpe, "BATCH_BYTES", 2_000)
    rows = bpe.encode(documents(spark, texts).repartition(11), decoded=True).collect()  # 4 partitions
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (list(r.ids), bytes(r.decoded).decode()) == (ENCODING.encode_ordinary(text), text), text[:80]


def test_numbers_packed_for_the_shuffle():
    import numpy as np
    import pyarrow as pa

    for numbers in ([], [0], [5, 70_000, 2**31 - 1, 0], list(range(100_000))):
        data = bpe.packed(np.array(numbers, np.int32))
        assert bpe.unpacked(pa.py_buffer(data), len(numbers)).tolist() == numbers and len(data) < 2 * len(numbers) + 40
