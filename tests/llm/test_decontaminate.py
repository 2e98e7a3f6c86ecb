import random
import re

import numpy as np

from quire.llm import decontaminate as dc

from .helpers import ODD_TEXTS, babble, documents


def sellers(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(item, edits, seed):
    pick = random.Random(seed)
    chars = list(item)
    for _ in range(edits):
        at = pick.randrange(len(chars))
        kind = pick.randrange(3)
        chars[at : at + 1] = [] if kind == 0 else ["z"] if kind == 1 else [chars[at], "q"]
    return "".join(chars)


def case(spark):
    items = [(i, babble(1000 + i, n)) for i, n in enumerate((4, 8, 12, 20, 40, 60, 3, 30))] + [(50, None), (51, "too short"), (52, ""), (53, "?!")]
    items.append((60, items[4][1]))  # a repeated text
    texts = []
    for k in range(60):
        _, item = items[k % 8]
        n = len(dc.folded(item))
        body = edited(item, (k * 7) % (n // 10 * 2 + 2), k)
        texts.append(babble(k, 30) + " " + body + " " + babble(500 + k, 30))
    texts += [babble(9000 + k, 200) for k in range(10)] + ODD_TEXTS + [items[5][1].upper().replace(" ", "\n--"), items[3][1] + items[4][1], "It is Too: SHORT!", "not too shorted", "tooshort"]
    return texts, items, spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark):
    texts, items, benchmark = case(spark)
    got = {(r.doc_id, r.item_id): r.distance for r in dc.matches(documents(spark, texts), benchmark).collect()}
    want = {}
    for d, text in enumerate(texts):
        if not text or len(text) > 5000:
            continue
        for i, item in items:
            a, b = dc.folded(item), dc.folded(text)
            if 0 < len(a) < dc.Q + dc.LEAST_SHARED - 1 and f" {item} " in f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} ":
                want[d, i] = 0
            if text and len(a) >= dc.Q + dc.LEAST_SHARED - 1 and (distance := sellers(a, b)) <= dc.edit_budget(len(a)):
                want[d, i] = distance
    assert {k for k in got if len(texts[k[0]] or "") <= 5000} == set(want)
    assert all(got[k] == v for k, v in want.items())
    assert len(want) > 30


def test_pieces_lose_nothing(spark, monkeypatch):
    texts, items, benchmark = case(spark)
    docs = documents(spark, texts)
    whole = {tuple(r) for r in dc.matches(docs, benchmark).collect()}
    monkeypatch.setattr(dc, "PIECE_BYTES", 500)
    assert len(list(dc.pieces(benchmark))) > 2
    assert {tuple(r) for r in dc.matches(docs, benchmark).collect()} == whole
    kept = dc.remove(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _, _ in whole}


def test_empty_tables(spark):
    texts, items, benchmark = case(spark)
    docs = documents(spark, texts)
    assert dc.matches(docs.limit(0), benchmark).count() == 0
    assert dc.matches(docs, benchmark.limit(0)).count() == 0
    assert dc.remove(docs, benchmark.limit(0)).count() == len(texts)


def test_band_alignment_is_the_edit_distance():
    for seed in range(30):
        item = dc.folded(babble(seed, 20))
        text = dc.folded(babble(seed + 1, 5)) + edited(item.decode(), seed % 8, seed).encode() + b"xyz"
        first = len(dc.folded(babble(seed + 1, 5)))
        assert dc.banded(item, np.frombuffer(text, np.uint8), first - 20, 41)[0] == sellers(item, text)


def test_repetitive_texts_are_counted_piece_by_piece(monkeypatch):
    index = dc.Index([(1, "0" * 300), (2, "answer: 42."), (3, "zeros " * 4)])
    text = "0" * 3000 + " x"
    whole = [x.tolist() for x in index.bands(np.frombuffer(dc.folded(text), np.uint8))]
    monkeypatch.setattr(dc, "POSTINGS", 1000)
    assert max(len(i) for i, _ in index.hits(np.frombuffer(dc.folded(text), np.uint8))) < 1000 + 300
    assert [x.tolist() for x in index.bands(np.frombuffer(dc.folded(text), np.uint8))] == whole
    assert index.find([text, "the Answer -- 42", "answer 421", None, ""]) == [{1: 0}, {2: 0}, {}, {}, {}]
