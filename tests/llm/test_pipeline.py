import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, decontaminate, pii, toxicity

from .helpers import SF
from .test_jaccard import brute


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    toxic, near, clean, private, encoded = ({r.doc_id: r for r in s.collect()} for s in seen[1:])
    assert all(s.columns == docs.columns for s in seen[1:-1])
    every = {r.doc_id: r for r in docs.collect()}

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert set(toxic) == {i for i, s in scores.items() if s < 0.7}
    assert all(tuple(r) == tuple(every[i]) for i, r in toxic.items())

    order = sorted(toxic)
    heads = {order[c] for _, _, c in brute([toxic[i].text for i in order], 5, 80)}
    assert set(near) == heads

    items = [decontaminate.folded(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, r in near.items() if any(x and x in decontaminate.folded(r.text) for x in items)}
    assert set(clean) <= set(near) - whole and len(clean) >= len(near) - len(whole) - 1

    anchors = pii.automaton()
    assert set(private) == set(clean)
    assert all(r.text == pii.redacted(clean[i].text, anchors) and r.n_chars == len(r.text) for i, r in private.items())
    assert not any("@mail" in r.text for r in private.values())

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_tokenizer()), special_tokens={})
    assert {i: list(r.ids) for i, r in encoded.items()} == {i: encoding.encode_ordinary(r.text) for i, r in private.items()}


def test_run_and_odd_rows(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() == 2
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_stages_keep_columns_that_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, None, None, None, "a", 1, "x"), (1, text, None, None, None, "a", 1, "x"), (2, text.upper(), "en", "s", 5, "b", 2, "y"), (3, "z " * 150_000, "en", "s", 1, None, None, None), (4, None, "en", "s", 0, "c", 3, "z")]
    odd = spark.createDataFrame(rows, docs.schema.simpleString()[7:-1].replace(":", " ") + ", __tag string, component int, gram string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name == "byte-level BPE encoding and decoding":
            assert sorted(r.doc_id for r in out.collect()) == [1, 1, 2, 3, 4]
            continue
        assert out.columns == odd.columns
        kept = sorted(tuple(r)[:2] + tuple(r)[5:] for r in out.collect())
        whole = sorted(tuple(r)[:2] + tuple(r)[5:] for r in odd.collect())
        assert kept == ([r for r in whole if r[0] != 2][1:] if name == "n-gram Jaccard join" else whole)
